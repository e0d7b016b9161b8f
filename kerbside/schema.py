"""Schemas of the documents and tables; nothing is inferred."""

from __future__ import annotations

OBJECT = (
    "struct<id:int,tracked_id:int,class:string,confidence:double,bbox_2d:array<double>,reference_point:array<double>,sat_coords:array<double>,"
    "have_heading:boolean,have_measurements:boolean,default_heading:boolean,heading:double,speed_kmh:double,"
    "sat_floor_box:array<array<double>>,bbox_3d:array<array<double>>,frenet:array<double>,link_id:string,lane_no:int,heading_src:string,"
    "lane_snapped:boolean,lane_offset_m:double,wrong_way:boolean,proj_rejected:boolean>"
)
REPLAY = (
    "location_code string, mp4_path string, mp4_frame_count int, animation_frame_count int,"
    "meta struct<resolution:array<int>,fps:double,world:struct<epsg:int,origin_easting:double,origin_northing:double,ground_ellipsoid_h:double>>,"
    f"frames array<struct<frame_index:int,objects:array<{OBJECT}>>>"
)
CALIBRATION = (
    "meta struct<location_code:string,note:string>,"
    "undistort struct<resolution:array<int>,K:array<array<double>>,D:array<double>>,"
    "homography struct<H:array<array<double>>,anchors_list:array<struct<px:array<double>,lonlat:array<double>>>>,"
    "parallax struct<x_cam_coords_sat:double,y_cam_coords_sat:double,z_cam_meters:double,px_per_meter:double>,"
    "world struct<epsg:int,origin_easting:double,origin_northing:double,ground_ellipsoid_h:double>,"
    "use_roi boolean, roi_method string, roi_polygon array<array<double>>,"
    "heading_guidelines array<struct<sat:array<array<double>>,heading_deg:double>>, ref_method string, proj_method string"
)
DETECTION = "ts timestamp, frame int, cctv_id string, track_id int, class string, confidence double, speed_kmh double, heading_deg double, lon double, lat double, easting double, northing double"
CCTV = "cctv_id string, name string, lon double, lat double"
LINK = "link_id string, pts array<struct<x:double,y:double>>, directed boolean, lane_no int, from_node string, to_node string"
LABELS = "loc string, video string, fps double, width int, height int, frames array<struct<index:int,file:string>>, classes array<string>, roi array<double>, boxes array<struct<frame:int,track_id:int,class:string,bbox:array<double>>>"
PRIORS = "set string, class string, width double, length double, height double"

# Fixed value: the time of frame 0 of a clip without a time of its own.
BASE_TIME = "2026-01-01 00:00:00"
